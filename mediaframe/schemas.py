"""Explicit schemas of the JSON documents; nothing is inferred."""

from __future__ import annotations

POINT = "struct<t:double,speed:double>"
KEYED = "struct<`static`:{v},keyframes:array<struct<timeMs:double,value:{v},easing:string,bezier:array<double>>>>"
NUM, VEC = KEYED.format(v="double"), KEYED.format(v="array<double>")
# grade numbers: named sliders, the four wheels as three numbers each, hue ranges, curves as points
SLIDERS = "exposure brilliance contrast brightness highlights shadows saturation vibrance sharpness temperature tint".split()
COLOR = (
    "struct<" + ",".join(f"{n}:double" for n in SLIDERS) + "," + ",".join(f"{n}:array<double>" for n in ("lift", "gamma", "gain", "offset"))
    + ",hsl:map<string,struct<h:double,s:double,l:double>>,curves:struct<" + ",".join(f"{n}:array<array<double>>" for n in ("master", "r", "g", "b"))
    + ">,lutAssetId:string,lutIntensity:double,vignette:double,grain:double>"
)
REFRAME_TRACK = "struct<sourceWidth:int,sourceHeight:int,keyframes:array<struct<frame:bigint,timeMs:double,crop:array<double>,zoom:double,tx:double,ty:double>>,reason:string>"
CLIP = (
    "struct<id:string,assetId:string,trackId:string,startMs:double,inMs:double,outMs:double,"
    f"speed:struct<preset:string,points:array<{POINT}>,opticalFlow:boolean>,"
    f"transform:struct<position:{VEC},scale:{NUM},rotation:{NUM},opacity:{NUM},blur:{NUM}>,"
    f"audio:struct<gainDb:double,normalize:boolean,muted:boolean,voice:string,keepPitch:boolean,fadeInMs:double,fadeOutMs:double,volume:{NUM}>,"
    f"mask:struct<shape:string,feather:double,rect:{VEC},inverted:boolean>,blendMode:string,freezeFrame:struct<atMs:double,holdMs:double>,reversed:boolean,"
    "label:string,linkId:string,fadeInMs:double,fadeOutMs:double,transitionIn:struct<type:string,durationMs:double>,"
    "effect:struct<type:string,intensity:double,params:map<string,double>>," f"color:{COLOR},reframe:{REFRAME_TRACK}>"
)
TRACK = f"struct<id:string,kind:string,name:string,locked:boolean,muted:boolean,role:string,clips:array<{CLIP}>>"
ASSET = ("struct<id:string,path:string,name:string,kind:string,durationMs:double,width:int,height:int,fps:double,hasAudio:boolean,codec:string,"
         "sceneTags:array<string>,`order`:int,orderReason:string,stems:map<string,string>,stemOf:struct<assetId:string,stem:string>>")
BEAT = "struct<timeMs:double,strength:double,kind:string>"
PROJECT = (f"version int, id string, name string, fps double, width int, height int, assets array<{ASSET}>, tracks array<{TRACK}>, beatMarkers array<{BEAT}>, "
           f"universalAdjust struct<enabled:boolean,name:string,values:{COLOR}>, frameInterpolation string")
SHOT = "struct<`index`:int,startFrame:bigint,endFrame:bigint,startMs:double,endMs:double,confidence:double,method:string,`cast`:array<string>>"
INSTANCE = "struct<trackId:bigint,label:string,bbox:array<double>,score:double>"
FINDING = f"struct<shotIndex:int,frame:bigint,timeMs:double,primary:{INSTANCE},duplicate:{INSTANCE},similarity:double,character:string,characterName:string>"
AUDIO = "struct<integratedLufs:double,truePeakDb:double,recommendedGainDb:double,beats:array<double>,tempoBpm:double>"
CUT = "struct<fromShot:int,toShot:int,flowMagnitude:double,smoothness:double,suggestion:string>"
REFRAME = f"struct<shotIndex:int,track:{REFRAME_TRACK}>"
ANALYSIS = f"version int, clips array<struct<path:string,asset:{ASSET},shots:array<{SHOT}>,duplicates:array<{FINDING}>,reframe:array<{REFRAME}>,audio:{AUDIO},transitions:array<{CUT}>>>"
PROBE = ("streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,duration:string,nb_frames:string,"
         "disposition:map<string,int>,side_data_list:array<struct<rotation:double>>>>, format struct<duration:string,format_name:string>")
MANIFEST = ("characters array<struct<id:string,name:string,species:string,`unique`:boolean,prompts:array<string>,features:string,references:array<struct<image:string,boxes:array<array<double>>>>,"
            "notLike:string,aliases:array<string>,zeroShot:array<string>>>, genericPrompts array<string>, negatives array<string>")
ADJUST = f"version int, name string, values {COLOR}"
EVENT = "event string, stage string, clip string, pct double, message string, level string, path string"
